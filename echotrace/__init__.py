"""Duplicate and near-duplicate search over Spark tables."""
