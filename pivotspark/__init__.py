"""pivotspark: Spark-native analytics over labelled activation vectors and
evaluation runs (probe training, steering transforms, paired run analysis,
per-token effects and gating), written on DataFrames, Spark SQL, MLlib and
Structured Streaming."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that it
# need not be installed on the executors or on the driver's working path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
