"""Operators for preparing language-model training data; see ``entry.py`` for the registered queries."""
