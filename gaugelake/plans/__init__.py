"""Queries over the driver's tables, and the command line."""
