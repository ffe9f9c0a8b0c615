"""Document and table analytics written for Spark: every operator takes and returns DataFrames."""
