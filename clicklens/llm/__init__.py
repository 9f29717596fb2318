"""Operators and the pipeline that prepare training text for language models."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: functions sent to them carry their helpers along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
