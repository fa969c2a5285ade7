"""Training-data operators: one module per operator, queries in ``registry``."""

import sys

from pyspark import cloudpickle

# Worker functions of all modules below travel with the job: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
