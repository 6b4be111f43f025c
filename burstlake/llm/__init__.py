"""Operators for training-data work on text and category counts.  Nothing outside this subpackage imports it."""
