"""Event-sequence analytics and anomaly detection as Spark DataFrame operations."""
