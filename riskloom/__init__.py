"""riskloom: cleaning, linking, scoring and checking of transaction tables on Spark.

Every operator takes and returns DataFrames.  Sub-packages:

* ``sources``    readers and writers (CSV tables, JSON lines, reports, staging)
* ``functions``  column expressions (coercion, text, ranks, literals)
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      whole jobs put together from the operators
"""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with the job, so executors do not need
# the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
