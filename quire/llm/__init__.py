"""Training-data operators: deduplication, quality, mixing, extraction, tokenisation, language-model scores."""
