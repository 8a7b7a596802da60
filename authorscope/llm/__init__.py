"""Operators of a training-data pipeline. Nothing outside this folder imports it.

The package is pickled by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
