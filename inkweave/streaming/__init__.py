"""Streaming entry points: edges that arrive as files."""
