"""Safety-test campaign analytics on Spark."""
