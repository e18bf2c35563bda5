"""Knowledge-graph analytics on Spark DataFrames.

Resources, typed values, links, hierarchies and permissions are plain tables;
every operator is a function from DataFrames to a DataFrame.
"""
