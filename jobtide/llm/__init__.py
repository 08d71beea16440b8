"""Operators of a training-data pipeline over documents and conversations."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the Python workers whole: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
