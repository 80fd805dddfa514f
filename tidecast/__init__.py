"""Retail demand analytics on large panels of daily series, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from tidecast.session import build_session, cut_lineage

# Executors need not have this package installed: its task functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage"]
