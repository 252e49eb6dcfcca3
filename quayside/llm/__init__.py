"""Operators for training-data pipelines over tables of documents. Nothing else in the library imports them."""
