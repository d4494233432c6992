"""Quote conversion analytics and pricing as Spark DataFrame jobs."""
