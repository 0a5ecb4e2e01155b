"""Library-circulation analytics as declarative Spark plans."""
