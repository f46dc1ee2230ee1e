"""Training-data operators: packing, deduplication, quality, language-model scores, tokenizers."""
