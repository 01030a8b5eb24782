"""Readers, writers and the engine's tables."""
