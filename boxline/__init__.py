"""Spark jobs over UI-screenshot detections, labels, text lines and frames."""

import sys

from pyspark import cloudpickle

# Task code is shipped with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
