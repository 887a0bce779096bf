"""corvane: a Spark-native engine for retrieval-training data and corpus preparation."""
