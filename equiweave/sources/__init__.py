"""Readers and writers of graph, alignment, candidate and result files."""
