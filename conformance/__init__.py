"""Registered queries and their SQL twins over the supplied tables."""
