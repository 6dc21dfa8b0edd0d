"""Operators for preparing text collections as training data."""
