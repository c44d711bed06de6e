"""Operations of a training-data pipeline: archives, cleaning, de-duplication, mixing, token files."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
