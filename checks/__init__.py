"""Queries over the given tables, one per operator, with the SQL each must agree with."""
