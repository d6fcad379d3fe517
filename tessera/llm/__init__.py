"""Training-data operators: dedup, near-dedup, LM scoring, BPE, ANN, licences, packing, language, toxicity, URLs."""
