"""Workflows, and the queries that the driver runs with their SQL."""
