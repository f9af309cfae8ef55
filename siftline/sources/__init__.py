"""Scans that bring heterogeneous listings into one lead schema."""
