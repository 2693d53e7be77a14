"""Readers, writers and the catalogue."""
