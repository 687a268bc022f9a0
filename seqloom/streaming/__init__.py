"""The ordered operators as Structured Streaming queries with carried state."""
