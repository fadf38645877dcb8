"""Readers and parsers that turn files and tool output into fact tables, and the report sink."""
