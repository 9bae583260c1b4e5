"""Streaming of gridloom."""
