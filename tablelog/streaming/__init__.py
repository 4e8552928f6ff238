"""Structured Streaming into log tables."""
