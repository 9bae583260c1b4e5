"""Functions of gridloom."""
