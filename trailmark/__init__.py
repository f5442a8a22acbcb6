"""Spark-native analytics over observation streams: detections, tracks, identities, presence and metrics."""
