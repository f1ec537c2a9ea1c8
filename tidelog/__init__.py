"""A change log of keys, resolved, compacted and stored with Spark DataFrames."""
