"""tagmill: molecular-barcode (UMI) analytics and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
