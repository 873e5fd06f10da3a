"""Source-repository analytics and retrieval as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that a cluster
# needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
