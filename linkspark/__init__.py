"""Record linkage and corpus operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers whole: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
