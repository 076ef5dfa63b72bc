"""Operators for preparing training text, and the pipeline stages built from them.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface, and ``catalog`` registers one query per operator over the given tables.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
