"""Scalar functions: expressions of Spark where it has them, pandas functions otherwise."""
