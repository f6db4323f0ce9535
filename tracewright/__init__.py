"""Statistical fault localisation over execution traces, as Spark jobs."""

__version__ = "0.1.0"
