"""Registered queries with the SQL they are held against, and composed plans."""
