"""veritrove: declarative data-quality rules and profiling on Spark."""
