"""Training-data operators: fingerprints, token output, quality, mixing,
chat formatting, packing, near-duplicates, line dedup, rules, token counts."""
