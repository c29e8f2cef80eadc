"""Operators for pipelines of training data."""
