"""Multifractal measurement of many ordered numeric series as Spark jobs."""

import sys

from pyspark import cloudpickle

from scalefold.session import build_session, release

# Functions used in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "release"]
