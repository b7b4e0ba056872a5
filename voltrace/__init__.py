"""Event-time vehicle telemetry analytics on PySpark."""
