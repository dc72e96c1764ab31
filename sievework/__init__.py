"""Sievework: curation of large sequence and text collections on Spark.

The package's functions reach Python workers by value, so that a cluster needs
no installed copy of it and no ``--py-files``.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
