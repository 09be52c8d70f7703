"""Spark-native search, discovery and ingestion analytics over a research-paper corpus."""
