"""Analytics over scored transcripts and documents, on Spark DataFrames."""
