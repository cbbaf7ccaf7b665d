"""Training-data operators: scans, deduplication, classifiers, mixing, packing, media."""
