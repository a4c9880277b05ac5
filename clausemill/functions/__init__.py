"""Column functions: text rules, numbers, nulls, arrays, and the few that need Python."""
