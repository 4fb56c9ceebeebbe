"""runledger: run and artifact analytics on Spark.

The few functions that run in executor Python workers (``mapInPandas``,
``applyInPandasWithState``) live in this package.  Registering the package
with PySpark's cloudpickle makes them travel with the tasks by value, so
executors need no copy of the package installed.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - very old PySpark: ship the package with --py-files
    pass
