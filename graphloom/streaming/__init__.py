"""Graphs fed by Structured Streaming."""
