"""Whole flows made of the operators: ingestion, search, answers."""
