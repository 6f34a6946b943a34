"""trackweave: a PySpark-native record matching and metadata enrichment engine."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so it needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
