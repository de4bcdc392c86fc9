"""Operations for preparing training text: each module is one operator over DataFrames."""

import sys

from pyspark import cloudpickle

# tasks get these functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
