"""Operators for large text corpora: one module per operator, see the README.

Functions of this package travel to the executors by value, so a cluster needs
no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
