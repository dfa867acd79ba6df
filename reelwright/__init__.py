"""Spark-native analytics over facts about media files, and over the text tables of a training corpus."""
