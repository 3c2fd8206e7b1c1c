"""costplan: a budget-aware analytics engine on PySpark DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions sent to Python workers travel by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
