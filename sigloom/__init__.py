"""Spark-native engine for daily signal panels, relational work and streams."""
