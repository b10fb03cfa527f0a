"""Scalar functions, grids and group terms."""
