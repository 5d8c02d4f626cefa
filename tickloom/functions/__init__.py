"""Column functions: parsing, chunks, matching."""
