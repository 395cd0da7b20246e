"""Vehicle telemetry analytics on Spark: cleaning, event detection, metrics, insights."""
