"""feedcore: curate regulatory and news feeds with Spark DataFrame jobs."""
