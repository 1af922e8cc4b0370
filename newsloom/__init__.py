"""newsloom: a Spark-native engine for news analytics and training-corpus preparation."""
