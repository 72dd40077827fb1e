"""Reads of living collections: index lookups, lists, id sets, fuzzy search and anchors."""
