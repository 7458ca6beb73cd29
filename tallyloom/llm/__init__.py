"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import tallyloom

# Executors get the functions themselves, so they need no copy of the package.
cloudpickle.register_pickle_by_value(tallyloom)
