"""Storm road-risk analytics as Spark jobs."""
