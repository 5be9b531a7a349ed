"""Training-data operators: quality, tokens, deduplication, sharding, scoring."""
