"""Column functions: text rules, keys, embeddings."""
