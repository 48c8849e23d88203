"""Ordered-bar analytics on PySpark."""
