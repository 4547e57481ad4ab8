"""Primitives: the operators that features are made of."""
