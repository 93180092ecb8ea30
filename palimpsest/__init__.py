"""palimpsest: provenance-aware evidence analytics as Spark DataFrame jobs."""
