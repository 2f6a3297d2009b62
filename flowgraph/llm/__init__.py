"""Training-data operators: dedup, token counts, packing, language and privacy rules."""
