"""faultline: telemetry anomaly analytics as Spark DataFrame operators."""
