"""Operators for building language-model training corpora on Spark.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
