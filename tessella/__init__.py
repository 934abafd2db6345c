"""tessella: reshaping data between structures with Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to the executors with the job, so they need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
