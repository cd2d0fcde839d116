"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

The functions that run in Python workers are pickled by value, so that executors need only the
third-party libraries and not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
