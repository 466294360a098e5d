"""Spark-native analytics over categorical observations: cluster ecology, attribution and training-data preparation."""
