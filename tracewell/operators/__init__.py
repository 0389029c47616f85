"""Relational operators: derivations, lookups, scorers and the ranking cascade."""
