"""The query model."""
