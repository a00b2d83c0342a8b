"""Streaming extensions; batch semantics are the reference point."""
