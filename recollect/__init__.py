"""recollect: agent-memory analytics and corpus preparation as Spark jobs."""
