"""tessera: corpus building, auditing and paired evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel by value, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
