"""Spark-first analytics for splat scenes, imaging sonar, image statistics and catalogs."""
