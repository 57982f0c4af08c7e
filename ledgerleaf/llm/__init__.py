"""Training-data operators: filters, near-duplicate detection, search, mixing and packing.

Nothing else in the library imports this subpackage. Functions that run on the
executors are pickled by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
