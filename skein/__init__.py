"""Skein: graph analytics over PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
