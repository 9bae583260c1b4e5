"""Operators of gridloom."""
