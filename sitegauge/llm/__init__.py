"""Operators for preparing training text: tokens, secrets, vectors, addresses, toxicity, copies, licences, language model,
quality rules and source mixing.

Every operator takes DataFrames and column names and returns a DataFrame.  Functions that run in tasks are shipped by
value, so executors need Spark's Python and the named third-party libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
