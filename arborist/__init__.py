"""Arborist: hierarchical clustering of points in R^d, declared as Spark plans."""
