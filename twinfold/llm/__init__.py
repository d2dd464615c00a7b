"""Training-data operators: packing, mixing, media, fingerprints, near-duplicates, language, urls, quality, licenses."""
