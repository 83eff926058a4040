"""plumbline: dataset statistics and text-corpus preparation, planned as Spark jobs."""
