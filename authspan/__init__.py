"""authspan: identity-threat analytics over authentication event logs, on Spark DataFrames."""
