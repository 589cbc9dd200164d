"""Column functions: calendar, units, names and text."""
