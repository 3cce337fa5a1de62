"""loomtext: Spark-native operators for parallel text (bitext) corpora."""
