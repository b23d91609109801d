"""Operators on text and vectors for building training corpora. Nothing else in the package imports this one."""
