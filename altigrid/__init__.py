"""altigrid: gridded height analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers inside tasks travel with the plan, so executors need not have this package
# installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
