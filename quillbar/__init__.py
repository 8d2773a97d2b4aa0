"""Analytics over price bars as Spark plans."""
