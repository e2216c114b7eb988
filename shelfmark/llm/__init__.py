"""Training-data operators: language ID, deduplication, archives, packing, tokenizing, media, personal data."""
