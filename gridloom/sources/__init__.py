"""Sources of gridloom."""
