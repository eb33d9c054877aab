"""Bindings of the sample tables and the catalogue of runnable queries."""
