"""Readers of landed data, small dimensions, and the registry of sources."""
