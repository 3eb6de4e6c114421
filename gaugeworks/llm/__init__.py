"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Functions that run in tasks travel by value, so executors need no copy of this package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
