"""probeweave: replicate-based probe measurements and DNA site tables on Spark DataFrames."""
