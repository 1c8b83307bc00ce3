"""Spark operators for evaluating, comparing and sampling segmentation-style predictions."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers inside the task closures, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
