"""Spark jobs that turn connection logs into labelled, model-ready flow features."""
