"""Operators for training-data text; nothing outside this subpackage imports it."""
