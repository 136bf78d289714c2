"""ledgerloom: event-sourced inventory analytics on PySpark.

The package is declarative: every operator takes DataFrames and returns a DataFrame. Functions that run
in Python workers are shipped by value, so executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
