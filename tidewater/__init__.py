"""Lakehouse data operators as PySpark DataFrame functions.

Every operator takes DataFrames and returns DataFrames; the clock and all
thresholds are parameters, so a run can be repeated and checked.
"""
