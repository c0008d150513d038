"""tablewright: Spark-native catalog extraction, matching and governance."""
