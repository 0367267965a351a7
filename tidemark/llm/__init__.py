"""Training-data operators: token counts, search, packing, scans, cleaning and deduplication."""
