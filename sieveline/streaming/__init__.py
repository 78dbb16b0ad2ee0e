"""Streaming of the evidence engine."""
