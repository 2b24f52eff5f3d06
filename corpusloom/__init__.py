"""A Spark-native engine for text corpora: clean, chunk, track changes, embed, retrieve and cite."""
