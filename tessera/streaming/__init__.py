"""The batch analytics as Structured Streaming queries."""
