"""A PySpark-native vector engine: exact and approximate neighbour search, versioned
storage, proximity graphs, table comparison and reference checks, all as DataFrames."""
