"""Structured Streaming: alignments that arrive as files."""
