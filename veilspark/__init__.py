"""Spark-native detection, redaction, tokenisation and audit of personal data."""
