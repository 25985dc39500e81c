"""Structured Streaming over a folder that documents are dropped into."""
