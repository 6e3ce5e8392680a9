"""Readers, writers and synthetic volumes."""
