"""Operators for training-data pipelines; nothing else in the package imports them."""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Workers that cannot import this package get its functions with the task.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
