"""Training-data operators: deduplication, filters, archives, sharding, mixing and packing."""
