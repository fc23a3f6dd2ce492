"""Spark-native job-market analytics: normalise, merge, classify, index, search and measure."""
