"""Security-log anomaly analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so the executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
