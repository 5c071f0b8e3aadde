"""Tabular analytics, retrieval and conversation operators for Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Ship this package's functions inside the tasks, so that executors need no installation of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
