"""Spark-first analytics for terrain illumination and visibility."""
