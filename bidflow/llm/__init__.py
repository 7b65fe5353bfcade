"""Operators for corpora of training text, and their queries.

Functions of this subpackage travel to the executors by value, so a cluster
needs no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
