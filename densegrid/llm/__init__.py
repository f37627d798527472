"""Operators for preparing training text: tokens, deduplication, extraction, scoring, mixing, archives."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this package, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
