"""siteloom: site-content analytics and migration planning on Spark."""
