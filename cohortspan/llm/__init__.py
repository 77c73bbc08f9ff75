"""Training-data operators: quality, secrets, archives, deduplication, tokens and mixing over document tables."""
