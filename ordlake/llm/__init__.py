"""Training-data operators: deduplication, filtering, mixing, media and tokens."""
