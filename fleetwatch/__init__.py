"""Security and performance analytics over robot-fleet telemetry, on PySpark."""

__version__ = "0.1.0"
