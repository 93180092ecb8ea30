"""Part of the palimpsest library."""
