"""DataFrame operators that tree queries are lowered to."""
