"""Profiling, cleaning, feature engineering and AutoML for flat tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the Python workers by value, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
