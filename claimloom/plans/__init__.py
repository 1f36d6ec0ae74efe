"""Plans of claim and evidence analytics."""
