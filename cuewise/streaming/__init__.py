"""Streaming extensions (ours): segments of words as they arrive."""
