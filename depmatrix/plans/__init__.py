"""Matrices derived from tables, whole analyses, and the registered queries."""
