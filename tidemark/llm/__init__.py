"""Training-data operators: deduplication, decontamination, extraction, tokenisation, scoring."""
