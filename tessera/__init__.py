"""Tessera: array, vision and table analytics expressed as Spark relations."""

__version__ = "0.1.0"
