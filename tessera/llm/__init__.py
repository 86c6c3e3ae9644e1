"""Training-data operators: language-model scoring, quality rules, sharding, byte-level BPE,
toxicity, line dedup, benchmark decontamination, near-duplicates, substring dedup, URL filters."""
