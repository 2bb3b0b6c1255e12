"""Retrieval analytics over document collections, as DataFrame transformations."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value: these then need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
