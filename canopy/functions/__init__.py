"""Column functions of tree queries."""
