"""Reconciliation of financial-report tables over large document corpora, on Spark."""
