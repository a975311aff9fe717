"""Training-data operators: text scoring, deduplication, filtering, formatting, media and tokens."""
