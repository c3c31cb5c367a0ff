"""Training-data operators: deduplication, tokenisation, archives, quality, mixing and scoring."""
