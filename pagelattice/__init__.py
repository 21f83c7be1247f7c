"""Site and corpus analytics as declarative Spark DataFrame programs."""
