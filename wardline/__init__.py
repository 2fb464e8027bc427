"""Clinical record jobs as Spark DataFrame functions."""
