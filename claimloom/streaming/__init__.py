"""Streaming of claim and evidence analytics."""
