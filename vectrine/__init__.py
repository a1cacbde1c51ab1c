"""A PySpark-native engine for dense-vector retrieval and corpus preparation.

Everything here is a function from DataFrames to a DataFrame.  Plans stay lazy
wherever Spark can express the step; the modules say where a stage has to be
materialised and why.
"""
