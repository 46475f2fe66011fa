"""symlattice: code-structure graph analytics and corpus preparation on Spark DataFrames."""
