"""corpusmill: Spark-native preparation and analysis of language-model training data."""
