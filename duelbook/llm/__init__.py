"""Operators of a training-data pipeline: one module for each, with their queries in ``queries``.

Functions that run in Python workers are sent by value, so the workers need the third-party libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
