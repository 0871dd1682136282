"""clade: gap-optimised clustering and data preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so the cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
