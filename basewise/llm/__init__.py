"""Operators for large training-text pipelines; nothing else in basewise imports them."""
