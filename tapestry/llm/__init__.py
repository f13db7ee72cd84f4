"""Text operators for training-data pipelines: scoring, search, near-duplicate
removal, decontamination, mixing, formatting and token output.

Each module holds one operator with its own general interface; ``registry``
binds them to the given tables.  Nothing outside this folder imports it.
Python functions of this package travel to the executors by value, so the
package need not be installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
