"""Training-data operators: filtering, near-duplicates, search, packing, encoding, extraction."""
