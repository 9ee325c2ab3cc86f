"""Spark-native data-quality engine: profile, propose, check, adapt, gate, report."""

import sys

from pyspark import cloudpickle

from .schemas import Rule
from .session import build_session, scratch_path

__all__ = ["Rule", "build_session", "scratch_path"]

# Functions that run in Python workers travel with the job; executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
