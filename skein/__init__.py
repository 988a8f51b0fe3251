"""Spark-native analytics over archives of coding-agent session transcripts."""
