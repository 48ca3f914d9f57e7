"""Training-data operators: packing, chat formatting, extraction, privacy, scoring, deduplication, quality and storage."""
