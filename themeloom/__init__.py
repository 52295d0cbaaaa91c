"""Topic analytics for large free-text collections, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
