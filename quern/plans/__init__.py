"""Queries over the test tables, each beside the SQL that it is checked against."""
