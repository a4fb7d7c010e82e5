"""Structured Streaming jobs over landed report files and tables."""
