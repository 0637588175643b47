"""lapwing: recommendation and diversity analytics on behaviour logs, as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
