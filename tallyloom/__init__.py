"""tallyloom: a PySpark-native analytics engine for code-review data."""

import sys

__version__ = "0.1.0"

try:  # ship the kernels themselves to the executors, so these needn't have the package installed
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except ImportError:  # the pure-Python parts need no Spark
    pass
