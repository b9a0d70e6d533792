"""Record linkage, metadata analytics and training-data preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the job itself, so
# executors need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
