"""Spark-native curation engine: contracts, validation, publication, review and streaming."""
