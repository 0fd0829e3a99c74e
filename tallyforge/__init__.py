"""tallyforge: a Spark-native engine for catalogue and listing analytics."""
