"""Operators for large training-data text collections; nothing outside imports this subpackage."""
