"""weftline: design-token and layout analytics over captured pages, as plain Spark DataFrames."""
