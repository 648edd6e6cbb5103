"""tidende: a PySpark-native news-analytics engine.

Every operator is a function from DataFrames to a DataFrame; Catalyst picks the physical plan.
"""
