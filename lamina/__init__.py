"""Layout and numeric analytics written as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
