"""Schemas, the snapshot store, generators and the view of an event table as telemetry."""
