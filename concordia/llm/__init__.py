"""Training-data operators: ten large-scale corpus operators and their queries.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are pickled by value, so executors need only the public libraries.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
