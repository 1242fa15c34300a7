"""Training-data operators: tokenizing, filtering and deduplicating a text corpus."""
