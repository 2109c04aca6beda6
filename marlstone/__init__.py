"""Spark-native annotation and curation engine for source code and documents."""
