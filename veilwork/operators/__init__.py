"""Relational operators: span resolution, masking, header rules, reports."""
