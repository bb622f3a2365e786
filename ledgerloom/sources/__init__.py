"""Readers that turn documents into element, line, row and cell DataFrames."""
