"""Subpackage of meshlake."""
