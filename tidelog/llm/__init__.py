"""Operators for training data; optional, nothing outside this folder imports it."""
