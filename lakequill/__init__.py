"""A Spark-native engine for document retrieval, its evaluation and the relational work around it."""
