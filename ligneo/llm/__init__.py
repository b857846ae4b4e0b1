"""Operators on text corpora, embeddings and web pages for training-data pipelines; nothing outside imports them."""
