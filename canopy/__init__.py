"""canopy: tree queries and corpus operators on Spark DataFrames."""
