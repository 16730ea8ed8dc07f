"""quillspark: a Spark-first text analytics, retrieval and library engine."""
