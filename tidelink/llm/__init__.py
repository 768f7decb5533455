"""Operators for building text training data; nothing else in the library imports them."""
