"""Seeded and spectral algorithms on one matrix, in numpy, without Spark."""
