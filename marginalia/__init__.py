"""marginalia: discrete-probability analytics as Spark jobs.

Functions of this package that run in Python on executors are sent there by
value, so only the driver needs the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
