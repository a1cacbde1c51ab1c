"""Relational, vector and text operators."""
