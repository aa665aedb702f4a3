"""Training-data operators: packing, near-duplicates, language-model scoring,
quality rules, language identification, URL filters, line deduplication, HTML
extraction, piece encoding and embedding near-duplicates."""
