"""lakesearch: batch and streaming evidence retrieval over text collections, on Spark."""

import sys

from pyspark import cloudpickle

# Python helpers that run inside tasks travel with the plan, so executors need
# no separate install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
