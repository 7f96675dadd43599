"""Incremental content capture as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
