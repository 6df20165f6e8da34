"""Operators for training-data pipelines: text, pages, vectors and conversations to shards of tokens."""
