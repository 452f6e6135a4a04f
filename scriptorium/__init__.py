"""A wiki-content analytics engine on Spark DataFrames."""
