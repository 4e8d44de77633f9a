"""Interval quantile features of series, and the relational studies around them, as Spark jobs."""
