"""Operators of a pipeline for training data; nothing else in the library imports them."""
