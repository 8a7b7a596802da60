"""Whole jobs over files, commits and snippets."""
