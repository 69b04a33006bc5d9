"""spanforge: intervals, events, sampled signals and their supports as Spark DataFrames."""
