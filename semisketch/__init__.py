"""Fingerprints of semi-structured documents on Spark."""

import sys

from pyspark import cloudpickle

# Arrow functions run on executors that may not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
