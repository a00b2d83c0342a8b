"""DataFrame operators over blocks."""
