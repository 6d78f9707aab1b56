"""Operators for building training data from documents. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to Python workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
