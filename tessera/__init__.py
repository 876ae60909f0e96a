"""Block-image analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that executors run travel with their task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
