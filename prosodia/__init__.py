"""Spoken-text preparation and speech-signal analytics expressed as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors by value, so that these need no copy of it on their path.
register_pickle_by_value(sys.modules[__name__])
