"""Record sort, verification and planning on Spark."""
