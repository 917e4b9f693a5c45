"""Empty: the inventory has no operator on unbounded data."""
