"""grainfold: retrieval, grounded-answer evaluation and corpus analytics as Spark DataFrame programs."""
