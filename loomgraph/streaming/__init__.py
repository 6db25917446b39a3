"""The row-local operators under Structured Streaming."""
