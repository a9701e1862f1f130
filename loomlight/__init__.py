"""loomlight: Spark-native log, transcript and text analytics."""
