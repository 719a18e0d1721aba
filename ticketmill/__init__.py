"""Support-ticket analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the functions they run with the job, so the package need not be installed on
# the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
