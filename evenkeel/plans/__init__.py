"""Whole runs of a strategy, and the catalogue of driver queries."""
