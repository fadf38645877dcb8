"""Structured Streaming variants of batch operators (extensions: the batch forms define the results)."""
