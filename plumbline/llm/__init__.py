"""Operators of a training-data pipeline."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tasks get the code with their function: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
