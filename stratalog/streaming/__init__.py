"""The same state kept by Structured Streaming."""
