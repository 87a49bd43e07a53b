"""Training-data operators: dedup, filtering, scanning, tokenizing."""
