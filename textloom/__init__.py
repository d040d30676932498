"""A PySpark engine for document corpora: chunking, quality, retrieval and training-text operators."""
