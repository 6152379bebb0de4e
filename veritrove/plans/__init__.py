"""From rule specs to few, wide Spark jobs."""
