"""Operators of a training-data pipeline over tables of text and urls.

Every operator is a function of DataFrames that returns a DataFrame (or writes files to the shared
folder and returns a DataFrame over them).  Nothing outside this subpackage imports it.
"""
