"""cellmill: a Spark-native engine for sparse count corpora and their metadata."""
