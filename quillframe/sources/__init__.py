"""Catalog, storage, nested tables and files."""
