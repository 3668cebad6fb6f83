"""Text-quality analytics on Spark: DataFrame and SQL operators for scoring, gating and summarising texts."""
