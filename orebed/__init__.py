"""Asset analytics as DataFrame operations on Spark."""
