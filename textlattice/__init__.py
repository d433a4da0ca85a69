"""textlattice: a PySpark-native statistical text-analytics engine."""

__version__ = "0.1.0"
