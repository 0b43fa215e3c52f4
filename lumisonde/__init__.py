"""Spark-native analytics for speech-authenticity data: cleaning, splitting, scoring, metrics, streams."""
