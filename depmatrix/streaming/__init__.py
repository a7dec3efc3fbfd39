"""Structured Streaming sources of matrices."""
