"""Leakage-safe walk-forward count forecasting on Spark DataFrames."""
