"""Gaugelake: Spark-native auditing of repeated measurements and of the models trained on them."""

__version__ = "0.1.0"
