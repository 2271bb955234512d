"""Corpus analytics and training-data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions reach the workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
