"""Diagram-graph analytics as lazy Spark plans."""
