"""Training-data operators: dedup, tokenisation, mixing, models, scans, search and extraction."""
