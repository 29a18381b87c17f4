"""Layered (cascade) forest classification on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .config import ForestConfig

# task functions travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ForestConfig"]
