"""Operators for building training corpora, each written as a Spark job."""
