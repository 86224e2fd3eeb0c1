"""Queries over the driver tables and the SQL each of them must agree with."""
