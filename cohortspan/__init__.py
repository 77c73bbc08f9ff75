"""Longitudinal cohort analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
