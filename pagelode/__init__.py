"""A Spark-native engine for text retrieval and link analysis over web pages."""

import sys

from pyspark import cloudpickle

# Functions of the package go to executors by value, which need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
