"""Tallymark: a Spark-native data reconciliation and analytics engine."""
