"""Evidence-backed signal analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
