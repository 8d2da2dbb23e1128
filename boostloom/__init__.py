"""Boosting and weak learning expressed as Spark DataFrame plans."""
