"""gleanery: content intelligence and corpus preparation as Spark jobs."""
