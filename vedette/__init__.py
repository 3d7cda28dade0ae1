"""vedette: security-telemetry analytics as Spark DataFrame jobs."""
