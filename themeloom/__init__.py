"""Thematic analysis of text collections as plain Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
