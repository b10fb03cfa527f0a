"""Sparse-group feature discovery over aligned sequences, planned by Spark."""
