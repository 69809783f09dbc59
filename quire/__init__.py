"""quire: corpus-scale document segmentation, batch inference and rebuild on Spark."""

import sys

from pyspark import cloudpickle

# The few Python steps travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
