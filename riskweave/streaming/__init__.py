"""Structured Streaming jobs."""

from pyspark import cloudpickle

import riskweave

# Stateful processors travel to the workers with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(riskweave)
