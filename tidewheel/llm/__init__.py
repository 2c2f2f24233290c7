"""Operators for large text-corpus pipelines; the rest of the library does not import them."""
