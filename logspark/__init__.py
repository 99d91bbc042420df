"""A PySpark library for log and metric processing."""
