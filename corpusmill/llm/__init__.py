"""Operators for preparing training data for language models, and their registered queries.

The functions that run in Python workers are shipped by value, so the executors need not have this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
