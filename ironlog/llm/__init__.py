"""Operators for preparing language-model training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
