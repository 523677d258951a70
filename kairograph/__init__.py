"""kairograph: a Spark-native bitemporal graph ledger with retrieval."""
