"""Streaming queries of the engine."""
