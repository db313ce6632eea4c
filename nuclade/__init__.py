"""A library of sequence and corpus operators on Spark DataFrames."""
