"""Operators for training-data pipelines. Nothing else in the library imports this package.

Task functions travel by value, so executors need only the listed libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
