"""Training-data operators: tokens, fingerprints, decontamination, archives, packing, secrets, quality, near-duplicates."""
