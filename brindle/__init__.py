"""An analytics engine in PySpark: DataFrame operators, a SQL front end and retrieval.

Functions that run on executors are shipped by value: workers need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
