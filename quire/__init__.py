"""quire: analytics over large collections of paged documents, on Spark DataFrames."""
