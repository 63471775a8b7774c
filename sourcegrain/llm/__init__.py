"""Training-data operators: filtering, deduplication, mixing, packing, search and extraction."""
