"""Content-based similarity retrieval and corpus preparation on Spark."""
