"""Readers, writers and the table layout they share."""
