"""A Spark-native engine for customer-journey analytics."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

# Workers that cannot import the package get its functions with the task.
if str(Path(__file__).resolve().parents[1]) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
