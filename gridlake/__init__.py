"""gridlake: earth-observation and household-survey analytics on Spark DataFrames."""
