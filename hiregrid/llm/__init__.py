"""Operators for preparing training data: text in tables in, decisions and texts out."""
