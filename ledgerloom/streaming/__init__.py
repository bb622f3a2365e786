"""Job-progress streams and their batch twins."""
