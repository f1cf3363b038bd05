"""Price-anomaly analytics for market data, written for Apache Spark.

Every public function takes and returns DataFrames; nothing here collects rows to the driver.
"""
import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
