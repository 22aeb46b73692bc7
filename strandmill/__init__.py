"""Spark-native preparation of sequence corpora."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in tasks by value: executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
