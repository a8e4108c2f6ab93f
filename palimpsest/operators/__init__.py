"""Operators over rows of segments, spans and requests."""
