"""gabarit: road-restriction analytics and data cleaning on PySpark DataFrames.

Functions that run in Python workers are sent to them whole, so that executors need not have this package on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
