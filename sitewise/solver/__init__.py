"""Sparse-group-lasso solvers: a numpy kernel, and its distribution over grids and column blocks."""
