"""Post-archive analytics on Spark."""
