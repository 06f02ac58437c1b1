"""logweir: log analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

from logweir.session import broadcast_if_small, prepare, settle

__all__ = ["broadcast_if_small", "prepare", "settle"]

# Functions that run in Python workers travel with the job, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
