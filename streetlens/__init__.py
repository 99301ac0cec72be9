"""streetlens: a PySpark-native analytics engine for object detections in street-level video."""

__version__ = "0.1.0"
