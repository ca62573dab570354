"""Corpus preparation and exact vector retrieval as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the job, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
