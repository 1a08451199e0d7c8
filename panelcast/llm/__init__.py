"""Operators for large-scale training-data pipelines; nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so that tasks
run on clusters where the package itself is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
