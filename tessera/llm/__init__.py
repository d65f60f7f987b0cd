"""Training-data operators: filters, near-duplicate joins, extraction, packing and classifiers over text tables."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
