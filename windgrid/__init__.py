"""Wind-resource and representative-period statistics as Spark DataFrame functions."""
