"""Corpus pipelines and retrieval analytics as Spark DataFrame transformations."""
