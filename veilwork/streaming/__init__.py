"""The same column functions on unbounded input."""
