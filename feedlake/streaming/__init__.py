"""Structured Streaming jobs over landed payloads and items."""
