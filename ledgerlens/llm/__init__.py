"""Training-data operators: deduplication, language, length, search, scoring, encoding, mixing and quality."""
