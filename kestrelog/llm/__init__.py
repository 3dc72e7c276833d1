"""Training-data operators: tokenization, deduplication, filtering, extraction."""
