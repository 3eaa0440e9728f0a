"""brindle: sparse-feature learning and data preparation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
