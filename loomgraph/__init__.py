"""loomgraph: a typed-property-graph and context-selection engine on PySpark.

Functions that run in Python workers are pickled by value, so a cluster needs no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
