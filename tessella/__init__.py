"""tessella: sparse matrix products and graph preparation as Spark DataFrame plans.

A matrix is a DataFrame of coordinate entries ``(i LONG, j LONG, v DOUBLE)``;
an absent entry is zero.  Everything in this package returns lazy DataFrames
so Catalyst plans, prunes and pushes filters down; nothing is collected except
scalars and size-checked small tables.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python workers (pandas UDFs, mapInPandas bodies)
# travel with the job by value, so executors need no installed copy of this
# package and no particular working directory.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from tessella.matrix import ENTRY_SCHEMA, Matrix, as_entries, check_product_shapes  # noqa: E402

__all__ = ["ENTRY_SCHEMA", "Matrix", "as_entries", "check_product_shapes"]
