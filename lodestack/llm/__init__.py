"""Training-data operators: dedup, decontamination, filters, extraction, formats and tokenizers."""
