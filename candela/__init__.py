"""candela: market time-series analytics as Spark jobs."""
