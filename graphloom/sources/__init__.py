"""Graphs, their tables, and files."""
