"""docloom: typed semantic documents as DataFrames."""
