"""Spark-native triage, retrieval and evaluation of short narratives."""
