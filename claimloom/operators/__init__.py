"""Operators of claim and evidence analytics."""
