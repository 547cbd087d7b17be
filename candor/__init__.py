"""Review-credibility analytics as Spark jobs: clean, aggregate, audit, profile and score review tables."""
