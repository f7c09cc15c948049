"""Spark-first engine for web-decision data: crawl ingest, page states, weak labels, dataset building, scoring and evaluation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
