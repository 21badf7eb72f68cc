"""Operators on text for training data. Nothing outside of this subpackage imports it."""
