"""Training-data operators: scans, near-duplicate search, archives, classifiers and mixing."""
