"""Spark-first analytics over code graphs, text corpora and embeddings."""
