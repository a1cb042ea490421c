"""Writing-integrity analytics as Spark DataFrame, SQL, ML and streaming jobs."""

import sys

from pyspark import cloudpickle

# Python functions used inside tasks travel with the job, so that executors need no copy of
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
