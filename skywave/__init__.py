"""Spark jobs that find signals in radio recordings, and jobs for large text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
