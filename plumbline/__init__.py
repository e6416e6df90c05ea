"""Fidelity statistics of synthetic panels, and training-data operators, on Spark."""
