"""Scalar semantics: missing values, storage types, the expression language."""
