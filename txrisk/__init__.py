"""Transaction-risk analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
