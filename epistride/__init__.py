"""Episodic trajectory analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from epistride.columns import COLUMNS, Columns

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["COLUMNS", "Columns"]
