"""veritab: evidence-bounded tables computed with Spark DataFrames."""
