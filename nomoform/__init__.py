"""Interpretable risk models as Spark tables."""
