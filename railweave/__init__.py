"""railweave: text-to-route analytics on Spark DataFrames."""
