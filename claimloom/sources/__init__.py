"""Sources of claim and evidence analytics."""
