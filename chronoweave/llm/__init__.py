"""Training-data operators: similarity joins, classifiers, dedup, scoring, packing, extraction and encoding."""
