"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage. Each operator module has a general interface;
``queries.py`` holds the thin registered queries.
"""
