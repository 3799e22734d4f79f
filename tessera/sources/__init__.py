"""Scans, sinks and the views that shape the given tables into the model."""
