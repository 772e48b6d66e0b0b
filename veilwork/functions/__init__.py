"""Column functions: span extraction and the detector registry."""
