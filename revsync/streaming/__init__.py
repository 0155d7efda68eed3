"""Structured Streaming: landing folders and webhook feeds into the canonical tables."""
