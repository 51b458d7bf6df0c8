"""Logs built from the given tables, and the registered queries over them."""
