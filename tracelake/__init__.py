"""Analytics over CPU execution traces, and over training data, as Spark jobs."""
