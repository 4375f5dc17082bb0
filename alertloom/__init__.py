"""Event-stream analytics on Spark: grouping, pattern mining, rule encoding, evaluation over time."""
