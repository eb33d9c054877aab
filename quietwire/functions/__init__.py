"""Column-level building blocks (no DataFrame is touched here)."""
