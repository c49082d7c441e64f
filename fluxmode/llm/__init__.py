"""Training-data operators: packing, dedup, language, privacy, quality and decontamination."""
