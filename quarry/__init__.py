"""Quarry: structural analytics over text artefacts, as Spark DataFrame plans.

Functions of this package that run on executors are pickled by value, so a
cluster needs only the library's dependencies, not the library itself.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
