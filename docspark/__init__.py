"""Structured rich-text documents and training-data operators on Spark."""
