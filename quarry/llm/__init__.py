"""Training-data operators.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need not have the library installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
