"""hearth: text-classification data work expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    schema-checked readers and writers (tables, metrics, head weights)
functions  Column-level building blocks (array maths, text helpers)
operators  DataFrame -> DataFrame operators (positional, encoder, scoring, ...)
plans      the registered queries and their DuckDB oracle SQL
streaming  the stateless scoring operators applied to a streaming source
"""

import sys as _sys

__version__ = "0.1.0"

# Functions defined in this package that run inside tasks (pandas UDFs,
# mapInPandas bodies, user scorer factories) are shipped by value, so executors
# need no copy of the package on their Python path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package instead
    pass
