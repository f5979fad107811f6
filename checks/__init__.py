"""Shared input views and the SQL that checks the queries."""
