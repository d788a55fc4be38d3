"""Scans of object folders, tables, datasets and query files."""
