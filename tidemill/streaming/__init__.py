"""Rolling sensor forecast on Structured Streaming."""
