"""lantern: media-catalog analytics and corpus preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
