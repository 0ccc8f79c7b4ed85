"""Operators for large-scale training-data preparation.

Nothing else in the library imports this package; it imports only the general
session helpers.  ``queries`` holds the registered queries and their SQL.
"""
