"""Scans, expansions and changes as DataFrame operations."""
