"""Functions of claim and evidence analytics."""
