"""Barloom: panel analytics for daily bars, written as Spark DataFrame programs.

A *panel* is a DataFrame with one row per (entity, date).  Every public operator takes DataFrames and
returns a DataFrame; nothing panel-sized passes through the driver.
"""

__version__ = "0.1.0"
