"""legflow: scheduled-movement analytics and table maintenance on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so that the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
