"""tidegrain: point-in-time analytics over append-only, late and corrected event logs, on Spark."""

__version__ = "0.1.0"
