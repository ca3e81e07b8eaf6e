"""finquarry: equity analytics as Spark jobs.

Every operator is a function of DataFrames and parameters that returns a DataFrame.
"""
