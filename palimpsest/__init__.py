"""Analytics of iterative text rewriting as Spark jobs."""
