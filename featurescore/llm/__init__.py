"""Training-data operators: deduplication, archives, mixing, scoring and scanning of text corpora."""
