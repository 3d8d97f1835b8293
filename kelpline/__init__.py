"""A Spark-native engine for multi-rate, episodic sensor data."""
