"""Spark-native analytics for multiplayer-game telemetry."""
