"""sievework: relational analytics over collections of source text, as Spark jobs."""
