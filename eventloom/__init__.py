"""Analytics over append-only event logs, as Spark DataFrames."""
