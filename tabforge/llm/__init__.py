"""Training-data operators: dedup, language, secrets, packing, archives. Nothing else in the library imports this package."""
