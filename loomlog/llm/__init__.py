"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
