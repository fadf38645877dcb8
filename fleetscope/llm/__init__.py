"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
