"""Spark-native analysis of text corpora and the entity networks inside them."""
