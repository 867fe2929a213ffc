"""KPI decision analytics and training-data operators as Spark jobs."""
