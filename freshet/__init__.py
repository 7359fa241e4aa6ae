"""freshet: hydroclimate time-series analytics on Spark DataFrames.

Every operator takes and returns a DataFrame.  The canonical daily table is
``(series_id STRING, date DATE, value DOUBLE)`` with at most one row per series and day, so
the rows of one series are bounded by the length of the calendar, however many raw records
feed that series.
"""
