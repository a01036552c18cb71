"""turnlake: a PySpark-native engine for conversational turn-taking corpora."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
