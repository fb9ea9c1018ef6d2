"""Training-data operators: extraction, deduplication, mixing, tokenising, media."""
