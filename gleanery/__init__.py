"""Gleanery: a Spark-native engine for curating and evaluating agentic training data."""
