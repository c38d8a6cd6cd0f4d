"""Column-level building blocks (native expressions only)."""
