"""swellcast: hourly time-series preparation, diagnostics, forecasting and
back-testing as Spark DataFrame operators."""

import sys as _sys

try:  # ship the package's Python helpers to executors by value (no install on workers)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass

__version__ = "0.1.0"
