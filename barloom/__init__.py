"""Market-panel analytics on Spark."""
