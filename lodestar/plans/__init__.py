"""Queries on the bound tables, each with its SQL."""
