"""Column functions: text, field parsing and display formatting."""
