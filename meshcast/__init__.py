"""Spatio-temporal sensor-grid analytics on Spark DataFrames."""
