"""Operators for preparing text corpora on Spark; nothing else in the library imports this."""
