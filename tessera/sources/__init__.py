"""Readers of tables, books and files."""
