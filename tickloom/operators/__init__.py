"""Operators over series and points: selection, aggregation, catalog, statistics, codec, lifecycle."""
