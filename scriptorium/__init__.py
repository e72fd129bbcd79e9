"""Document extraction and analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package: functions that go to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
