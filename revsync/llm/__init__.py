"""Operators of a training-data pipeline: dedup, decontamination, filters, counts, mixing.

Functions that run in tasks are sent along with them, so workers need not have this package.
What is broadcast is plain data.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
