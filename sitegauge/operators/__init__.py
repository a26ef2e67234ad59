"""Relational and statistical operators, each a function from DataFrame to DataFrame."""
