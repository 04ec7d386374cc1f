"""Registered queries: each operator on the given tables, with the SQL that must give the same rows."""
