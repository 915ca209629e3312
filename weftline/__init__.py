"""weftline: a Spark-native engine for trajectory, batch and corpus data."""
