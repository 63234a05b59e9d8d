"""cuelog: timed-text and pipeline-log analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; every scalar function
takes and returns Columns.  See README.md for the operator list.
"""
