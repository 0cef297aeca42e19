"""Repository-graph analytics on Spark."""
