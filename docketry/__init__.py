"""Search, classification and record keeping for intellectual-property documents on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from docketry.plans.collection import Collection
from docketry.functions.filters import ExactFilter, RecordFilter
from docketry.functions.vectors import BatchEmbedder, HashingEmbedder

__all__ = ["BatchEmbedder", "Collection", "ExactFilter", "HashingEmbedder", "RecordFilter"]
