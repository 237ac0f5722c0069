"""tidemark: Spark-native distillation, change tracking and analytics of crawled web pages."""
