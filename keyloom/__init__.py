"""Keyspace analytics on Spark: commands over typed collections as bulk DataFrame operators.

Functions shipped to Python workers are pickled by value, so executors need no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
