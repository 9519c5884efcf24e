"""Tracks and maps of vehicle fleets from sensor rows, on Spark."""

import sys

from pyspark import cloudpickle

# tasks carry this package's functions with them, so executors need no copy of it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
