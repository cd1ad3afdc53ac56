"""Readers of points and writers of graphs."""
