"""Scalar rules on strings and keys, as Python functions and as column expressions."""
