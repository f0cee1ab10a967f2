"""Jobs: several operators composed into one plan that yields the next table."""
