"""nichefold: Spark-native ranking, grounding and evaluation over spatial, per-entity data."""
