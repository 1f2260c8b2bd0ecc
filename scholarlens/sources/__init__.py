"""Readers, writers and the table shapes they produce."""
