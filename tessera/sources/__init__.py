"""Readers of files and tables, and sinks."""
