"""Operators for training-data pipelines over tables of documents and pages; nothing else in the library imports them."""
