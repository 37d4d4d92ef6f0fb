"""evq: event studies, as-of features, risk and retrieval as Spark DataFrame jobs."""
