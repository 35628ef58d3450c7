"""laborlens: labour-market analytics as Spark DataFrame jobs."""
