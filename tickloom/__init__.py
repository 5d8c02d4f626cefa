"""Analytics on recent time-series metrics, as Spark plans."""
