"""Operators for preparing training data.  Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
