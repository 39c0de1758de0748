"""Spark-native corpus analytics: text corpora and chat logs into audited fine-tuning data."""
