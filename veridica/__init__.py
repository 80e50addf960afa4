"""Analytics for confidence-aware evidence retrieval on Spark."""
