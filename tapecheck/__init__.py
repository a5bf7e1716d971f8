"""Stability checks for fixed trading rules on panels of price bars, on Spark."""

__version__ = "0.1.0"
