"""Crater-pattern registration analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
