"""Streaming of the panel library."""
