"""Training-data operators: dedup, filtering, extraction, mixing and encoding of text corpora."""
