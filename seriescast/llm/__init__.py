"""Operators of a training-data pipeline over ``documents`` tables.

Nothing else in the library imports this package.  ``queries`` holds the
registered queries and their DuckDB SQL.
"""
