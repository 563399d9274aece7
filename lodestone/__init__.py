"""Code analytics and corpus processing on Spark."""
