"""A Spark-first analytics engine for court-sport tracking tables."""

import os
import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parents[1])

if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    # Workers may not be able to import this package by name, so its functions travel with the tasks.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
