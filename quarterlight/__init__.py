"""Policy-signal analytics and training-data preparation as Spark jobs."""
