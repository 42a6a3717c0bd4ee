"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with its own interface. ``queries`` registers one
query per operator, which runs it over a whole table. Functions that run inside
Python workers are shipped by value, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
