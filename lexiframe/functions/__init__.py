"""Column functions. Everything here is a Catalyst expression over one row."""
