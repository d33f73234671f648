"""Spatial co-localisation analytics as lazy Spark DataFrame operators."""
