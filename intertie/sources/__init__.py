"""Readers of market report files and tables, and the writers of derived tables."""
