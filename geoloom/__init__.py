"""Spark-native analytics for earth-observation, annotation and corpus tables."""
