"""Training-data operators: similarity joins, classifiers, extraction, packing.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside this
subpackage imports it; ``queries.py`` holds the registered queries.
"""
