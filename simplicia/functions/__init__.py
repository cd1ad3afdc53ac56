"""Distances, lens functions, scale selectors and linkages."""
