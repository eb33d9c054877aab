"""Passive network-traffic analytics expressed as Spark DataFrame jobs.

Every public function takes DataFrames (or ``Column`` values) and returns
DataFrames (or ``Column`` values).  Nothing is collected inside the library;
the caller decides when an action runs.
"""
