"""Network telemetry threat analytics as Spark DataFrame jobs."""
