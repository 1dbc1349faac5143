"""Operators that prepare text, vectors and pages as training data."""
