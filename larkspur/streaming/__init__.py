"""The same jobs over Structured Streaming sources."""
