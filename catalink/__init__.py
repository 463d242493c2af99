"""catalink: links free-text request lines to a product catalog, as Spark jobs."""
