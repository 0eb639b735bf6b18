"""Column functions: projection, number and time texts, display."""
