"""Operators for training-data pipelines over documents, vectors and conversations.

Nothing outside this folder imports it. Every operator takes DataFrames and
column names and returns a DataFrame of its own columns, so extra columns of the
input, whatever their names, never clash with those it adds.
"""
