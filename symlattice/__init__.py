"""Typed interface graphs on Spark: load, normalise, compare and report."""
