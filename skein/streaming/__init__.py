"""Graphs kept up to date from a stream of edges."""
