"""Search and comparison of product offers on Spark."""
