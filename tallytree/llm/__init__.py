"""Operators for large text corpora: deduplication, quality, mixing, packing, extraction, archives."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors as they are, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
