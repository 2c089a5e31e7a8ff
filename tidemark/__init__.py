"""tidemark: finds out what changed between snapshots of a dataset, on Spark."""

__version__ = "0.1.0"
