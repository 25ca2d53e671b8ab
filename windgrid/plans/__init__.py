"""Queries: thin plans over the operators, each beside its SQL."""
