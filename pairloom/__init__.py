"""pairloom: record linkage and candidate-matching analytics on Spark DataFrames."""
