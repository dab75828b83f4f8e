"""Analytics over collections of time-series signals, as Spark plans."""
