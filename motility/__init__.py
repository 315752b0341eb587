"""Cell motility analysis on Spark tables."""
