"""Operators for preparing training text. Nothing else in the library imports this package.

Functions that run on executors are pickled by value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
