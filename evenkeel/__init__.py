"""Load-aware work assignment on PySpark: poll, scale, index, pack, elect."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's few Python functions with them, so that executors need
# no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
