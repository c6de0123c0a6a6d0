"""stratalog: keyed, log-structured data as DataFrames."""
