"""Functions over columns. Those in Python travel to the workers by value, so
that executors need not have this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
