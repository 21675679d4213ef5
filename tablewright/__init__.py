"""Tables, questions and answers on Spark: a query engine made of DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are shipped whole, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
