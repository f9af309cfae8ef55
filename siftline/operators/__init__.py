"""Relational operators: keys, rule cascades, entity resolution, upserts, views."""
