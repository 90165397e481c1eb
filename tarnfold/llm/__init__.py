"""Training-data operators: formatting, counting, deduplication, filtering and encoding of text corpora."""
