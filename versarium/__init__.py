"""Versarium: text-corpus analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow helpers are shipped to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
