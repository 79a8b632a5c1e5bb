"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator with its own general interface; ``queries``
applies them to the test tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel with their tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
