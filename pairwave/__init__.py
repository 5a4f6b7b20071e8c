"""Paired-cohort analytics on Spark.

People are followed over repeated visits and linked in pairs within
households.  The package turns a long visit table and a baseline person
table into outcomes, dyads, risk tables and regression models.  Everything
is a function from DataFrames to DataFrames; column names are parameters.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that call them, so the
# executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
