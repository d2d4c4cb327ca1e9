"""Spatial, graph and table analytics as lazy PySpark DataFrame operators."""
