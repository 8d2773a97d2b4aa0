"""The same bars and averages over streams."""
