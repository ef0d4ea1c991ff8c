"""Trailmark: patterns over time-stamped records, as Spark DataFrame plans."""
