"""Vector operators: validation, exact and inverted-file search, clustering, index, recall, cache simulation."""
