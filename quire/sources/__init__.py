"""Readers, gates and writers."""
