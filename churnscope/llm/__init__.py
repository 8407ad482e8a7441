"""Training-data operators (dealt operators 1-13). Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions travel with the code of this subpackage, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
