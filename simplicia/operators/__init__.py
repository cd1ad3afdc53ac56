"""Operators on points, clusters and neighbour graphs."""
