"""Structured Streaming jobs; they run the same functions as the batch plans."""
