"""Structured Streaming forms of counting and mate pairing."""
