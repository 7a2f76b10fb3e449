"""Operators of a training-data pipeline: formatting, token files, mixing, fingerprints, near-duplicates,
quality, packing, token counts, licences, personal data, periodic runs, conversation repair and a quality classifier. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
