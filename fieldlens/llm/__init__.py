"""Operators for training text: deduplication, filtering, scoring, mixing and archives.

The functions that run inside tasks travel with the plan, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
