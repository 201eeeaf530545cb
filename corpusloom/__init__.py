"""Topic analytics over document collections, written as Spark DataFrame jobs."""
