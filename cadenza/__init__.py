"""Cadenza: music-set planning and corpus preparation as lazy Spark operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
