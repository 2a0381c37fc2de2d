"""Document search, analytics and corpus preparation as plain PySpark plans."""
