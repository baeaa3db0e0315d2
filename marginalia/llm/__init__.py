"""Training-data operators: packing, near-duplicate joins, deduplication, scoring, search, mixing and formatting."""
