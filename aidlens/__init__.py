"""Emergency-intelligence analytics as Spark DataFrame jobs."""
