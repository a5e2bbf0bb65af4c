"""Spark operators for timelines of activities and for training data."""
