"""Feature engineering, evaluation and ensembling over Spark DataFrames."""
