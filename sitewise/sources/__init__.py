"""Readers and writers: alignments, numeric tables, lists, trees, scores, catalogue."""
