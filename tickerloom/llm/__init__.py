"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Tasks get this subpackage's functions with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
