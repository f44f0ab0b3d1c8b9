"""Registered queries, by section of operators."""
