"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Each operator has a module of its own;
``queries`` registers the ``opN_<name>`` queries over the driver's tables.

The functions that run on executors are pickled by value, so executors need not have this package
installed: only public libraries (numpy, pyarrow, tokenizers, ...) are imported there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
