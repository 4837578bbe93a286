"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Workers need not find this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
