"""loomtext: long-context data preparation and scoring on Spark DataFrames."""
