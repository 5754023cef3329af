"""Change data and event streams with Structured Streaming."""
