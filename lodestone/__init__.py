"""Spark-native analytics over engineering artifacts: catalogue queries, lineage, snapshots, retention, design rules, network data."""
