"""Training-data operators: one module per operator, plus ``queries`` for the driver.

Nothing outside this package imports it.  The functions that run on executors
are shipped by value, so a cluster needs the public wheels but no copy of this
package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
