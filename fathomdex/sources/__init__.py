"""Catalog of indices, and readers and writers of their files."""
