"""A Spark-native engine for form extraction: matching, cleaning, fusing, scoring and dataset building as DataFrames."""
