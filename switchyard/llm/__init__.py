"""Training-data operators: text filters, scoring, deduplication, packing and sharding.

Nothing outside this subpackage imports it.  ``switchyard.llm.queries`` holds the registered queries.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
