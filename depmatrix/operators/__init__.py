"""Operators over element and edge tables: plain plans, and loops to a fix-point."""
