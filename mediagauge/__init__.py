"""Coverage-drift analytics for PySpark: profiles, drift, de-duplication, storylines, evaluation."""

__version__ = "0.1.0"
