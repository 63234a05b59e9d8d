"""Column functions and the ordered-computation helpers."""
