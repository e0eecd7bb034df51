"""Operators of a training-data pipeline.

Executors need only the public libraries: the functions that run there are
shipped by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
