"""Time-series alignment and timeline analytics on PySpark."""
