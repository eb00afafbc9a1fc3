"""Line-oriented text search on Spark, with an optional training-data toolkit."""
