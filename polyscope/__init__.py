"""polyscope: Spark-native analytics for multilingual multiple-choice evaluation data."""
