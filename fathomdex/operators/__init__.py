"""Search, aggregation, suggestion and mutation over DataFrames."""
