"""Palisade: security-telemetry analytics written as Spark DataFrame jobs."""
