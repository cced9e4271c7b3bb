"""A Spark-first engine for FITS 4.0 data: sources, sinks, column expressions and operators.

What runs on executors is pickled by value, so they need only public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
