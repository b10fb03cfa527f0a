"""Relational operators: sites, alleles, features, scores, metrics, ranks."""
