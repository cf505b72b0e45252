"""lakemill: DataFrame operators for Spark, from run-length encoding to hypothesis graphs."""
