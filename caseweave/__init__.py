"""caseweave: case-evidence analytics on Spark DataFrames."""
