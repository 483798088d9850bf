"""Cohort analytics as Spark jobs: long keyed tables in, long keyed tables out."""

import sys

from pyspark import cloudpickle

# Python steps carry their functions with them: workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
