"""Readers, writers and table-shaping helpers around the media tables."""
