"""Streaming focal points against a static reference."""
