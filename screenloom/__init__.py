"""Treatment-versus-control screen analytics as ordinary Spark plans."""
import sys

from pyspark import cloudpickle

# Functions that run inside Arrow tasks travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
