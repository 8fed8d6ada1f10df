"""Stored tables, their files and incoming record envelopes as DataFrames."""
