"""Relational operators over edges, texts, author lists and vectors."""
