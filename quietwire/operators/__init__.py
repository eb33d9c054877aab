"""Table-level operators: flows, features, windows, detection, evaluation."""
