"""Relational operators over transcript and result tables."""
