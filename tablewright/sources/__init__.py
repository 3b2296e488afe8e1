"""Readers, writers, option lists and previews."""
