"""Table analysis on Spark: profiling, statistics, text mining and modelling."""
