"""Readers, caches and sinks."""
