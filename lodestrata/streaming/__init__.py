"""Change feeds through Structured Streaming."""
