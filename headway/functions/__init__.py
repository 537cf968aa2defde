"""Column functions: geometry, labels, time and number helpers."""
