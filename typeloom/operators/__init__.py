"""Distributed operators: inference, validation, and relational views of records."""
