"""Query plans: the syntax tree, its parsers and its compiler to Spark columns."""
