"""Evidence-graph analytics and training-data operators written for PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a job also runs where the package
# is installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
