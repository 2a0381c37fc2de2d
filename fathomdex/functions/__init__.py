"""Column builders shared by queries, scoring and aggregations."""
