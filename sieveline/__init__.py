"""sieveline: privacy analytics and corpus preparation as Spark jobs."""

__version__ = "0.1.0"
