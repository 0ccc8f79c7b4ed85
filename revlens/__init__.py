"""revlens: product-review analytics expressed as Spark DataFrame jobs.

Sub-packages:
  functions  - scalar Column expressions (parsing, normalising, hashing)
  sources    - readers, schema checks and sinks
  operators  - relational jobs: dedupe, classify, reports, facets, labels, pages
  plans      - composed analyses and the query registry used by the driver
  streaming  - Structured Streaming forms of merge, weekly trend and dedupe
"""

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel with the job (by value), so
# executors need no installed copy and no particular working folder.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
