"""Queries and SQL oracles over the driver tables."""
