"""Operators for preparing language-model training text; see ``queries`` for what runs on the sample tables."""
