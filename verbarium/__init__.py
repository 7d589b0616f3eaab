"""Verbarium: a corpus and word-embedding analytics engine on Spark."""

import sys

from pyspark import cloudpickle

# executors need not have the package: functions that run there travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
