"""Document and translation-memory analytics on Spark.

What runs in Python on the executors is sent to them by value, so they need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
