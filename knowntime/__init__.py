"""knowntime: point-in-time equity analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and answers a whole table of
requests in one job, using only what was public at each request's instant.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel by value, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
