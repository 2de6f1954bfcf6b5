"""PySpark operators for sharded tensor datasets and the run logs around them."""

import sys

from pyspark import cloudpickle

from shardloom.spec import DatasetSpec

# Functions sent to executors carry their code along, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DatasetSpec"]
