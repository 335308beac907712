"""Readers, writers and the fixture views."""
