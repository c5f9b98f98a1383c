"""Compositions: the rebuild and report plans, and the query catalogue."""
