"""Event-panel analytics on Spark: DataFrame operators for dated event records."""
