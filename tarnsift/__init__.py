"""Text scanning and training-data operators for PySpark."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the plan, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
