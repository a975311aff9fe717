"""Inference and patch replay over streams."""
