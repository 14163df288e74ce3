"""A PySpark-native analytics engine for labelled sparse measurement data."""

from .model import Dataset

__all__ = ["Dataset"]
