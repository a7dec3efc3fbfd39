"""Readers and writers of matrices, edge lists, workbooks and projects."""
