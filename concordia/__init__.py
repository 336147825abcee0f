"""Evidence-fusion analytics on Spark: composable DataFrame -> DataFrame operators.

Functions that run in Python workers are pickled by value, so executors need
only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
