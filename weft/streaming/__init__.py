"""Streaming forms of the keyed rules."""
