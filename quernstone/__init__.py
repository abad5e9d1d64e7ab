"""Quernstone: structural feature engineering expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
