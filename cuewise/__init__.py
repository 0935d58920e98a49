"""Timed-text analytics on Spark: cues, words and transcripts as DataFrames."""
