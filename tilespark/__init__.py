"""Block-transform analytics on Spark."""
