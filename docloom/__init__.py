"""A Spark-first document analytics engine.

Functions of this package are pickled by value, so executors need no copy of
the package on their own disks: whatever the driver imported is what runs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
