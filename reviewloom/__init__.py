"""Review analytics on Spark: scoring, summarising and reporting over a star of reviews."""
