"""Quarryline: a PySpark-native engine for collecting, classifying, deduplicating, scoring and searching postings."""
