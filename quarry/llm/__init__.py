"""Training-data pipeline operators: deduplication, decontamination,
quality scoring, licence scans, tokenised output, packing, chat formatting,
exact vector search and main-text extraction."""
