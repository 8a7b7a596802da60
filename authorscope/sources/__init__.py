"""Readers for file and commit tables and for raw directory trees."""
