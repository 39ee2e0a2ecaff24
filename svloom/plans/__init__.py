"""Queries over the synthetic tables, each with the SQL that checks it."""
