"""Column functions and Arrow-backed text functions."""
