"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may use the rest.
Each module holds one operator with its own general interface; ``queries``
holds the thin queries that apply the operators to the shared tables.
"""
