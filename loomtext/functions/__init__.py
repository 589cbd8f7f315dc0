"""Column functions: text, metrics, arrays, preferences."""
