"""Streaming forms of listing operators."""
