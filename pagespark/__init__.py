"""pagespark: document-page analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
