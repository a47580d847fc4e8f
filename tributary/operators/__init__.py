"""Joins, partitioning, sorting and aggregates."""
